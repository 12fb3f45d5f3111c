"""License scans: k-gram hashes of the words vote for diagonals of templates, neighbouring diagonals merge, and spans
are verified by how much of the template they cover."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import WORD_HASH, Workspace, pick, shingles, small_batches

K = 4
#: Diagonals this near are one span; spans that cover so much of their template count.
NEAR, COVER = 3, 0.6
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: License notices in common use, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BASE = re.compile(b"(?<= )(?=(" + b"|".join(p.encode() for p in PHRASES) + b") )")


def license_words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a to z (A-Z lower-cased) and characters beyond ASCII."""
    return (text or "").encode().translate(_WORD).split()


def template_rows() -> list[tuple[int, str, int, int, int]]:
    """template, label, hash, place, number of k-grams; as many rows as the templates have words, about."""
    out = []
    for i, (label, text) in enumerate(TEMPLATES):
        grams = shingles(WORD_HASH.of(license_words(text)), K).view(np.int64).tolist()
        out += [(i, label, h, at, len(grams)) for at, h in enumerate(grams)]
    return out


@cache
def _template_hashes() -> np.ndarray:
    return np.unique(np.array([r[2] for r in template_rows()], np.int64).view(np.uint64))


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word, label) of each place where a phrase's words stand."""
    line = b" " + b" ".join(words) + b" "
    out, at, word = [], 0, 0
    for m in _BASE.finditer(line):
        word += line.count(b" ", at, m.start())
        at = m.start()
        out.append((word - 1, PHRASES[m[1].decode()]))
    return out


SCAN = "rid long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, hits array<struct<hash:long,at:long>>"


def scan_licenses(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    All rolling k-gram hashes of a document are sifted in the scan by those that templates have; what is left is joined
    to template positions (a broadcast of the fixed templates), and votes are summed by document, template and offset.
    `spans` has template, first and last word and coverage of each verified span. The score is the best coverage, or a
    half where only a phrase was found. A null or empty text has no words and no labels. Null and repeated ids are
    judged row by row. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "licenses")

    def run(batches):
        known = _template_hashes()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = license_words(t.as_py())
                places = base_places(words)
                hits = []
                if len(words) >= K:
                    grams = shingles(WORD_HASH.of(words), K)
                    near = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    at = np.flatnonzero(known[near] == grams)
                    hits = [{"hash": h, "at": p} for h, p in zip(grams[at].view(np.int64).tolist(), at.tolist(), strict=True)]
                first, last = (places[0][0], places[-1][0]) if places else (None, None)
                out.append((row, d, len(words), len(places), first, last, sorted({x[1] for x in places}), hits))
                row += 1
            columns = list(zip(*out, strict=True)) or [()] * 8
            types = [pa.int64()] * 6 + [pa.list_(pa.string()), pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64())]))]
            names = ["rid", "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "hits"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    scan = work.save(pick(docs, doc_id=doc_id, text=text).mapInArrow(run, SCAN), "scan")
    templates = spark.createDataFrame(template_rows(), "template int, label string, hash long, place long, grams long")
    hits = scan.select("rid", F.explode("hits").alias("hit")).select("rid", "hit.hash", "hit.at")
    votes = hits.join(F.broadcast(templates), "hash").withColumn("diagonal", F.col("at") - F.col("place"))
    votes = votes.groupBy("rid", "template", "label", "grams", "diagonal").agg(
        F.collect_set("place").alias("places"), F.min("at").alias("low"), F.max("at").alias("high")
    )
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > NEAR
    votes = votes.withColumn("far", F.coalesce(far, F.lit(False)).cast("int"))
    votes = votes.withColumn("span", F.sum("far").over(order))
    spans = votes.groupBy("rid", "template", "label", "grams", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"),
        F.min("low").alias("first"), (F.max("high") + K - 1).alias("last"),
    )
    spans = spans.withColumn("coverage", F.col("covered") / F.col("grams")).filter(F.col("coverage") >= COVER)
    found = spans.groupBy("rid").agg(
        F.collect_set("label").alias("own"), F.max("coverage").alias("best"),
        F.sort_array(F.collect_list(F.struct("template", "first", "last", "coverage"))).alias("spans"),
    )
    out = scan.drop("hits").join(found, "rid", "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("own", none)))
    score = F.coalesce("best", F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), score.cast("double").alias("score"), "spans",
    )
