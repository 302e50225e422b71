"""License scans (operator 8). DataFrame functions only.

Texts are lower-cased words without outer punctuation; a template matches where a window of the text holds
at least `contained` of the template's word shingles.  Windows of a template's size class (twice the next
power of two of its words) overlap by half, so any occurrence lies whole in one of them.  MinHash bands of
one row retrieve templates for a window.  A size class has as many bands as its worst template needs: from
the least Jaccard similarity of a full window that holds `contained` of the template's shingles (1/12 for
five words), so many that none agrees with a probability of `missed` at most.  Retrieved pairs are then
verified by exact shingle containment.

A window without any shingle of any template can not match; only windows around shared shingles are hashed,
so clean text costs one pass over its shingles, each looked up in one short bucket, and nothing is shuffled but
matches.  The templates are a parameter, a dict or a table (license, template) of whole license texts; together
they may have MOST_SHINGLES shingles, for the buckets are a constant of the plan.

Cases: null and empty texts, and texts shorter than a shingle, match nothing; templates shorter than a
shingle are refused; repeated rows of one id give one match; null ids are kept together as one; an empty
table gives an empty result; the input's other columns play no part.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.quality_rules import let
from palimpsest.llm.shared import small

#: Statements of common public licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}

#: Shingles of all templates together at most.
MOST_SHINGLES = 2_000_000
#: Rows of the templates' bands that are broadcast at most; a row holds a template's shingles.
MOST_BANDS = 20_000

SPLIT = r"[\s\p{Punct}&&[^-]]*[\s]+[\s\p{Punct}&&[^-]]*"


def words_of(text: Column) -> Column:
    """Lower-case words; punctuation at a word's edges, but for hyphens, is dropped."""
    return F.array_remove(F.split(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), SPLIT), "")


def bands_needed(shingles: int, held: int, contained: float, missed: float) -> int:
    """Bands of one row after which a window of `held` shingles that holds enough of a template's is missed with probability `missed`."""
    both = max(1, math.ceil(contained * shingles - 1e-9))
    jaccard = both / max(shingles, held + shingles - both)
    return 1 if jaccard >= 1 else math.ceil(math.log(missed) / math.log(1 - jaccard))


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, contained: float = 0.8, words_each: int = 5, bands: int = 64, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", missed: float = 2e-6) -> DataFrame:
    """bands: of a size class, at least; more where `missed` needs them. Returns id_col, license, containment (the best window's) and first_word (that window's first word, from 0), a row for each license of a document."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    hashed = lambda words: let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (words_each - 1)), lambda i: F.xxhash64(F.slice(h, i, words_each))))
    given = templates.select("license", "template") if isinstance(templates, DataFrame) else spark.createDataFrame(list(templates.items()), "license string, template string")
    given = given.withColumn("words", words_of(F.col("template")))
    known = [(r["license"], r["n"], r["shingles"]) for r in given.select("license", F.size("words").alias("n"), F.when(F.size("words") >= words_each, F.array_distinct(hashed(F.col("words")))).alias("shingles")).collect()]
    if short := [name for name, n, _ in known if n < words_each]:
        raise ValueError(f"templates of fewer than {words_each} words: {short}")
    size_class = {name: 2 << max(0, n - 1).bit_length() for name, n, _ in known}
    bands_of = dict.fromkeys(size_class.values(), bands)
    for name, _, s in known:
        z = size_class[name]
        bands_of[z] = max(bands_of[z], bands_needed(len(s), z - (words_each - 1), contained, missed))
    table = spark.createDataFrame([(name, size_class[name], s) for name, _, s in known], "license string, size int, template array<long>")
    every = sorted({s for _, _, x in known for s in x})
    if len(every) > MOST_SHINGLES:
        raise ValueError(f"templates of more than {MOST_SHINGLES} shingles")

    rows = docs.select(F.col(id_col).alias("id"), words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("words"))
    rows = rows.where(F.size("words") >= words_each).select("id", hashed(F.col("words")).alias("shingles"))
    # the templates' shingles in buckets of one or two, a constant of the plan
    n_buckets = 1 << max(0, len(every) - 1).bit_length()
    buckets: list[list[int]] = [[] for _ in range(n_buckets)]
    for x in every:
        buckets[x % n_buckets].append(x)
    table_of = F.from_json(F.lit(json.dumps(buckets)), "array<array<bigint>>")
    known_shingle = lambda x: F.array_contains(F.get(table_of, F.pmod(x, F.lit(n_buckets)).cast("int")), x)
    hits = F.array_compact(F.transform("shingles", lambda x, i: F.when(known_shingle(x), i)))
    rows = rows.withColumn("hits", hits).where(F.size("hits") > 0)
    # Windows start at multiples of half their size; each hit lies in two of them.
    def windows_of(size: int) -> Column:
        step = size // 2
        last = lambda i: F.floor(i / step).cast("int") * step
        starts = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.array(last(i) - step, last(i)))))
        return F.transform(F.filter(starts, lambda s: s >= 0), lambda s: F.struct(F.lit(size).alias("size"), s.alias("start")))

    windows = F.flatten(F.array(*map(windows_of, sorted(set(size_class.values())))))
    rows = rows.withColumn("w", F.explode(windows)).select("id", F.col("w.size").alias("size"), F.col("w.start").alias("start"), F.array_distinct(F.slice("shingles", F.col("w.start") + 1, F.greatest(F.col("w.size") - (words_each - 1), F.lit(1)))).alias("held"))

    n_bands = F.lit(bands)
    for z, n in bands_of.items():
        n_bands = F.when(F.col("size") == z, n).otherwise(n_bands)

    def least(held: Column) -> Column:
        one = lambda b: F.array_min(F.transform(held, lambda x: F.xxhash64(x, F.lit(seed * 1000 + b))))
        every = [F.struct(F.lit(b).alias("band"), one(b).alias("least")) for b in range(max(bands_of.values(), default=bands))]
        return F.array_compact(F.array(*[F.when(n_bands > b, x) for b, x in enumerate(every)]))

    banded = rows.withColumn("m", F.explode(least(F.col("held")))).select("id", "size", "start", "held", F.col("m.band").alias("band"), F.col("m.least").alias("least"))
    of_templates = table.withColumn("m", F.explode(least(F.col("template")))).select("license", "size", "template", F.col("m.band").alias("band"), F.col("m.least").alias("least"))
    met = banded.join(small(of_templates, MOST_BANDS), ["size", "band", "least"])
    share = F.size(F.array_intersect("held", "template")) / F.size("template")
    found = met.withColumn("containment", share).where(F.col("containment") >= contained)
    best = found.groupBy("id", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("at"))).alias("best"))
    return best.select(F.col("id").alias(id_col), "license", F.round("best.containment", 6).alias("containment"), (-F.col("best.at")).alias("first_word"))
