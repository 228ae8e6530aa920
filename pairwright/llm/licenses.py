"""License scans by diagonal voting.

A text's words (lower case) give a rolling hash for each run of k words; Spark joins all of them to the
places of the same runs in license templates. A match at word i of the text and word j of the template
votes for the diagonal i - j. Votes are added up by text, template and diagonal; diagonals a few words
apart are merged, as an insertion or a missing word shifts the rest. What is merged, and goes on in the template
after a gap in the text (a page header in the middle of a notice), is chained. What has enough votes is then
verified on the words themselves, along its diagonals only, which gives the spans and the share of the template that is there.

Templates are the usual notices and, from a folder if there is one (``TEXTS``), whole license texts by their
files' names.

Beside the templates, short phrases name licenses ("Base"): places where a phrase's words stand one after
another.

Texts are keyed by a hash of the text, so repeated texts are verified alike and a null or repeated id
does no harm; a collision could only add a candidate, which fails verification. A null text counts as
empty; texts of any length are read whole; each of several places of a template is a span; columns of other
names have no effect; an empty table gives no rows.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.llm.common import BROADCAST_ROWS, quoted, released, small, stored, table, text_batches, texts, utf8

K = 3
APART = 3
LEAST = 0.75
SHORT = 12
#: A folder of license texts, one a file.
TEXTS = os.environ.get("PAIRWRIGHT_LICENSES", "/usr/share/common-licenses")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: The usual notices, and short license texts.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "apache-2.0-notice": 'licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license',
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "mit-line": "released under the mit license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0",
    "cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "cc-by-sa-4.0": "licensed under cc by sa 4.0",
    "cc-by-4.0": "licensed under a creative commons attribution 4.0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights-reserved": "all rights reserved no part of this publication may be reproduced",
}

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def gram_hashes(found: list[bytes], k: int = K) -> np.ndarray:
    """A hash of each run of k words, joined by a space: differences of one running polynomial sum, modulo 2**64."""
    if len(found) < k:
        return np.zeros(0, dtype=np.uint64)
    line = np.frombuffer(b" ".join(found), dtype=np.uint8)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((line.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(line)), dtype=np.uint64)))
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    a, b = starts[: len(found) - k + 1], ends[k - 1 :]
    h = (sums[b] - sums[a]) * _powers(BACK, len(line))[a]
    return h ^ (h >> np.uint64(29))


def grams(keyed: DataFrame, k: int = K) -> DataFrame:
    """key, i, gram for each run of k words of each text. keyed: key long, t binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            at, count = [], 0
            for key, t in zip(keys.tolist(), texts(b.column(1))):
                h = gram_hashes(words(t), k)
                for s in range(0, len(h), 100_000):
                    part = h[s : s + 100_000]
                    at.append((key, s, part))
                    count += len(part)
                    if count >= 100_000:
                        yield batch(at)
                        at, count = [], 0
            if at:
                yield batch(at)

    def batch(at: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(h) for *_, h in at]
        key = np.repeat(np.array([k for k, *_ in at], np.int64), sizes)
        i = np.concatenate([np.arange(s, s + len(h), dtype=np.int64) for _, s, h in at])
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(i), pa.array(np.concatenate([h for *_, h in at]).view(np.int64))], names=["key", "i", "gram"])

    return keyed.mapInArrow(released(run), "key long, i long, gram long")


def texts_of(folder: str) -> dict[str, str]:
    """The license texts in a folder, by file name and "-text"; none if there is no such folder."""
    files = sorted(p for p in Path(folder).glob("*") if p.is_file() and not p.is_symlink()) if folder else []
    return {p.name.lower() + "-text": p.read_bytes().decode("utf-8", "replace") for p in files}


def template_grams(spark: SparkSession, templates: dict[str, list[bytes]], k: int = K) -> DataFrame:
    """template, j, gram of each run of k words; broadcast unless the templates given are too many."""
    rows = [(name, j, h) for name, found in templates.items() for j, h in enumerate(gram_hashes(found, k).view(np.int64).tolist())]
    df = spark.createDataFrame(rows, "template string, j long, gram long")
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def diagonals(matches: DataFrame, sizes: Column, apart: int = APART) -> DataFrame:
    """key, template, low, high, first, end, votes: neighbouring diagonals of matches (key, template, i, j),
    merged and chained. first, end: the words of the text between which the template would stand."""
    ends = [f(c).alias(n) for f, c, n in ((F.min, "i", "i0"), (F.max, "i", "i1"), (F.min, "j", "j0"), (F.max, "j", "j1"))]
    votes = matches.groupBy("key", "template", (F.col("i") - F.col("j")).alias("d")).agg(F.countDistinct("j").alias("n"), *ends)
    order = Window.partitionBy("key", "template").orderBy("d")
    far = F.coalesce(F.col("d") - F.lag("d").over(order) > apart, F.lit(True))
    runs = votes.withColumn("run", F.sum(far.cast("int")).over(order))
    outer = [f(n).alias(n) for f, n in ((F.min, "i0"), (F.max, "i1"), (F.min, "j0"), (F.max, "j1"))]
    runs = runs.groupBy("key", "template", "run").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.sum("n").alias("votes"), *outer)
    size = F.element_at(sizes, F.col("template"))
    along = Window.partitionBy("key", "template").orderBy("i0", "j0", "low")
    before = lambda c: F.lag(c).over(along)
    goes_on = (F.col("j0") >= before("j1")) & (F.col("i0") >= before("i1")) & (F.col("i0") - before("i1") <= size)
    chains = runs.withColumn("chain", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(along))
    chains = chains.groupBy("key", "template", "chain").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("votes").alias("votes"), *outer)
    first = F.greatest(F.col("i0") - F.col("j0") - apart, F.lit(0))
    return chains.select("key", "template", "low", "high", first.alias("first"), (F.col("i1") - F.col("j1") + size + apart).alias("end"), "votes")


def verify(found: list[bytes], template: list[bytes], low: int, high: int, first: int = 0, end: int | None = None) -> tuple[float, int, int]:
    """The share of the template's words that stand in order on these diagonals, and the span they take.

    The longest common sequence, within a band: a word of the text meets only the template's places on the
    diagonals. What stands before the band's first place stays as it is, what it enters starts from its neighbour.
    """
    first, size = min(max(0, low, first), len(found)), len(template)
    end = min(len(found), high + size, len(found) if end is None else end)
    row, span = [0] * (size + 1), [(first, first)] * (size + 1)
    reached = 0
    for i in range(first, end):
        a, b = max(0, i - high), min(size, i - low + 1)
        for j in range(reached, b):
            row[j + 1], span[j + 1] = row[j], span[j]
        reached = max(reached, b)
        above, above_span = row[a], span[a]
        w = found[i]
        for j in range(a, b):
            keep, keep_span = row[j + 1], span[j + 1]
            if w == template[j]:
                start = above_span[0] if above else i
                row[j + 1], span[j + 1] = above + 1, (start, i + 1)
            elif row[j] > row[j + 1]:
                row[j + 1], span[j + 1] = row[j], span[j]
            above, above_span = keep, keep_span
    best = row[reached]
    return best / max(1, size), *span[reached]


def needed(size: int, least: float = LEAST) -> int:
    """Words of a template of that size that must be there: all of a line, a share of a longer notice."""
    return size if size < SHORT else math.ceil(size * least)


def votes_needed(size: int, least: float = LEAST, k: int = K) -> int:
    """Half of the runs that stay when as many words are changed as may be: each takes k runs with it. The
    other half is for words put in between."""
    return max(1, (size - k + 1 - k * (size - needed(size, least))) // 2)


def phrase_places(text: bytes, found: list[bytes]) -> list[tuple[int, str]]:
    """(word, label) of each place of a phrase, sorted."""
    low = text.lower()
    out = []
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        if all(p in low for p in parts):
            out += [(i, label) for i in range(len(found) - len(parts) + 1) if found[i] == parts[0] and found[i : i + len(parts)] == parts]
    return sorted(out)


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, k: int = K, apart: int = APART, least: float = LEAST) -> DataFrame:
    """id, n_words, base (array of word, label), spans (array of template, start, end, share) for each row of docs."""
    templates = TEMPLATES | texts_of(TEXTS) if templates is None else templates
    kind = dict(docs.dtypes)[id_col]
    split = {n: w for n, t in templates.items() if (w := words(t.encode()))}
    keyed = text_batches(docs).select(F.col(quoted(id_col)).alias("id"), utf8(text_col).alias("t")).withColumn("key", F.xxhash64("t"))
    places = template_grams(docs.sparkSession, split, k)
    of = lambda f: F.create_map(*[x for n, w in split.items() for x in (F.lit(n), F.lit(f(len(w))))])
    runs = diagonals(grams(keyed.select("key", "t"), k).join(places, "gram"), of(int), apart)
    likely = runs.where(F.col("votes") >= F.element_at(of(lambda n: votes_needed(n, least, k)), F.col("template")))
    # A text's candidates: at most one for each place of the text and template, so bounded by the text itself.
    likely = stored(likely.groupBy("key").agg(F.collect_list(F.struct("template", "low", "high", "first", "end")).alias("likely")))
    shape = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
    base = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, places_, spans = [], [], []
            for t, some in zip(texts(b.column(1)), b.column(2)):
                found = words(t)
                checked = {}
                for x in some.as_py() or ():
                    share, s, e = verify(found, split[x["template"]], x["low"], x["high"], x["first"], x["end"])
                    if share * len(split[x["template"]]) >= needed(len(split[x["template"]]), least) - 1e-6:
                        checked[x["template"], s, e] = share
                counts.append(len(found))
                places_.append([{"word": i, "label": n} for i, n in phrase_places(t, found)])
                spans.append([{"template": n, "start": s, "end": e, "share": v} for (n, s, e), v in sorted(checked.items())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(places_, base), pa.array(spans, shape)], names=["id", "n_words", "base", "spans"])

    out = f"id {kind}, n_words long, base array<struct<word:long,label:string>>, spans array<struct<template:string,start:long,end:long,share:double>>"
    return keyed.join(small(likely), "key", "left").select("id", "t", "likely").mapInArrow(released(run), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    method = F.col("spans.template")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.col("base.label"), method))), ",").alias("labels"),
        # A notice: the share of it that is there. A phrase alone says the less the longer the text.
        F.coalesce(F.array_max("spans.share"), F.when(F.size("base") > 0, 0.5 + 0.4 * F.least(F.lit(1.0), 3 * F.size("base") / F.col("n_words"))), F.lit(0.0)).alias("score"),
    )
