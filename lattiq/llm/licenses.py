"""License scans by diagonal voting.

Templates are word sequences of common license texts.  Every rolling word k-gram of a document is joined, in
Spark, to the template positions that have it; a match votes for its diagonal (document position minus
template position).  Votes are aggregated by document, template and diagonal, neighbouring diagonals (words
left out or put in) are merged, and a merged span is kept if the matched k-grams cover enough of the template.

A k-gram's hash is a polynomial, modulo 2**64, in the 64-bit hashes of its words, rolled over all words of the text.
Verification counts the template's words that matched k-grams cover, so a chance equality of one hash makes no match.

Base phrases (``PHRASES``) are found in the same pass at their own places.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, list_array, text_bytes, with_row_key, words_of

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "apache-notice": """
        Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy
        of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-warranty": """
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES
        OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License.""",
    "mit-grant": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to
        deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
        sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions""",
    "mit-short": "Released under the MIT License.",
    "mit-warranty": """
        The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability,
        fitness for a particular purpose and noninfringement.""",
    "gpl-notice": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "gpl-short": "GNU General Public License, version 3",
    "gpl-warranty": """
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-conditions": """
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution.""",
    "mpl-notice": """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at""",
    "isc-grant": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""",
    "unlicense-dedication": """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
        this software""",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
}
GRAM = 3
#: Share of a template's words that matched k-grams must cover.
COVER = 0.6
#: Diagonals this close belong to one occurrence.
NEAR = 3


_BASE = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[bytes]) -> np.ndarray:
    """The hashes of all k-grams of words, by place."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(0, len(h) - GRAM + 1)
    code = np.zeros(n, np.uint64)
    for j in range(GRAM):
        code = code * _BASE + h[j : j + n]
    return code.view(np.int64)


class Templates:
    def __init__(self, templates: dict[str, str]):
        words = {k: words_of(t.encode()) for k, t in templates.items()}
        short = [k for k, w in words.items() if len(w) < GRAM]
        if short:
            raise ValueError(f"templates need {GRAM} words: {short}")
        self.rows = [(int(code), k, k.split("-")[0], at, len(w)) for k, w in words.items() for at, code in enumerate(grams(w))]


def _scan(phrases: dict[str, str]):
    targets = [([w.encode() for w in p.split(" ")], label) for p, label in phrases.items()]
    number = {w: k + 1 for k, w in enumerate(sorted({w for p, _ in targets for w in p}))}
    coded = [([number[w] for w in p], label) for p, label in targets]

    def run(batches):
        get = number.get
        for b in batches:
            every = text_bytes(b.column("text"))
            for s, e in by_bytes([t or b"" for t in every]):
                rows, codes = [], []
                for t in every[s:e]:
                    words = words_of(t or b"")
                    ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
                    found, labels = [], set()
                    for p, label in coded:
                        at = np.flatnonzero(ids[: max(0, len(ids) - len(p) + 1)] == p[0])
                        for j, w in enumerate(p[1:], 1):
                            at = at[ids[at + j] == w]
                        if len(at):
                            found.append(at)
                            labels.add(label)
                    all_ = np.concatenate(found) if found else None
                    rows.append((len(words), 0 if all_ is None else len(all_), None if all_ is None else int(all_.min()), None if all_ is None else int(all_.max()), sorted(labels)))
                    codes.append(grams(words))
                kinds = [pa.int64()] * 4 + [pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [b.column("__rid").slice(s, e - s), b.column("doc_id").slice(s, e - s), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list_array(np.concatenate(codes), np.array([len(c) for c in codes]), pa.int64())],
                    ["__rid", "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "codes"],
                )

    return run


def scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, cover: float = COVER, near: int = NEAR) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (labels of phrases), labels, score, spans for each row.

    spans: array<struct<from,to,template,label,cover>> of verified matches, by words.  score: the best cover,
    at least 0.5 where a base phrase stands.  Nulls and empty texts have no words and no labels (score 0);
    of equal covers all are reported; repeated rows are scanned each; other columns are ignored; no rows give
    no rows.  Templates are constants of the library or the caller's few texts, so their table is broadcast
    (at most 2^20 k-grams, checked).
    """
    spark = documents.sparkSession
    known = Templates(templates)
    if len(known.rows) >= 1 << 20:
        raise ValueError("templates hold too many words to be sent to every executor")
    table = spark.createDataFrame(known.rows, "code long, template string, label string, at long, length long")
    docs = with_row_key(documents.select("doc_id", "text"))
    schema = T.StructType([T.StructField("__rid", T.LongType()), documents.schema["doc_id"], *T._parse_datatype_string("n_words long, n_base long, first_word long, last_word long, base array<string>, codes array<long>").fields])
    own = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    # one pass: every row of a document carries its counts, its first row stays even without a match
    rolled = docs.mapInArrow(_scan(phrases), schema).select("__rid", *own, F.posexplode_outer("codes").alias("place", "code"))
    votes = (
        rolled.join(F.broadcast(table), "code", "left")
        .where("template is not null or place = 0 or place is null")
        .withColumn("diagonal", F.col("place") - F.col("at"))
    )
    by = ["__rid", "template"]
    diagonals = votes.groupBy(*by, "diagonal").agg(
        *[F.first(c).alias(c) for c in own], F.first("label").alias("label"), F.first("length").alias("length"), F.collect_set(F.struct("place", "at")).alias("hits")
    )
    order = Window.partitionBy(*by).orderBy("diagonal")
    opened = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= near, 0).otherwise(1)
    grouped = diagonals.withColumn("__open", opened).withColumn("occurrence", F.sum("__open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy(*by, "occurrence").agg(*[F.first(c).alias(c) for c in own], F.first("label").alias("label"), F.first("length").alias("length"), F.flatten(F.collect_list("hits")).alias("hits"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + (GRAM - 1)))))) / F.col("length")
    verified = merged.withColumn("cover", F.when(F.col("template").isNotNull(), covered).otherwise(0.0)).withColumn(
        "span",
        F.when(
            F.col("cover") >= cover,
            F.struct(F.array_min(F.transform("hits", lambda h: h["place"])).alias("from"), (F.array_max(F.transform("hits", lambda h: h["place"])) + GRAM).alias("to"), "template", "label", "cover"),
        ),
    )
    out = verified.groupBy("__rid").agg(*[F.first(c).alias(c) for c in own], F.sort_array(F.collect_list("span")).alias("spans"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("spans", lambda s: s["label"]))))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0))
    return out.select(*own, labels.alias("labels"), F.greatest(best, F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"), "spans")
