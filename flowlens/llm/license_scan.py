"""License scans: MinHash bands over overlapping windows, then exact containment; SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.llm.common import broadcast_below, let, spread_rows, stage, text_of, words_of

WIDTH = 5
CONTAINMENT = 0.8
#: Bands of so many rows each. A window that holds a template at that containment has a Jaccard
#: similarity of at least 0.55 with it (see ``window_step``), so it is met with probability
#: 1 - (1 - 0.55 ** 2) ** 24, which is above 0.9998; a whole template in its window, above 0.999999.
BANDS, ROWS = 24, 2

# Notices and openings of common licenses by their SPDX names.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
                "your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at "
                "your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                 "(at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                 "(at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
                 "(at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                 "(at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                     "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
                     "list of conditions and the following disclaimer in the documentation and/or other materials provided "
                     "with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
)


def plain_words(text: Column) -> Column:
    """Lower-case words without ASCII punctuation; a word of nothing else is none."""
    return words_of(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]+", ""))


def shingles(words: Column, width: int = WIDTH) -> Column:
    """Runs of ``width`` words joined by a space, repeats included; none if there are fewer words."""
    n = F.size(words)
    return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - width + 1),
                                          lambda i: F.array_join(F.slice(words, i, width), " "))).otherwise(
        F.array().cast("array<string>"))


def _hashes(words: Column, width: int) -> Column:
    n = F.size(words)
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(
        *(F.get(words, i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))


def band_keys(runs: Column) -> Column:
    """Keys of the MinHash bands of a set of shingles; equal sets have equal keys."""
    def least(hashes: Column, k: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k))))

    def keys(hashes: Column) -> Column:
        low = [least(hashes, k) for k in range(BANDS * ROWS)]
        return F.array(*(F.xxhash64(F.lit(b), *low[b * ROWS:(b + 1) * ROWS]) for b in range(BANDS)))
    return let(F.transform(F.array_distinct(runs), lambda s: F.xxhash64(s)), keys)


def window_step(shingle_count: int) -> int:
    """Places between windows. A window is so much longer than the template, less one, that it holds any
    place of it whole: at containment 0.8 the similarity is at least 0.8 m / (m + m / 4 + 0.2 m) > 0.55."""
    return max(1, shingle_count // 4)


@dataclass(frozen=True)
class Templates:
    """One row per text: license, its shingles, their number ``m``; and what is read off the table."""
    table: DataFrame
    sizes: list[int]
    known: list[int]


def load_templates(spark: SparkSession, rows=TEMPLATES, width: int = WIDTH, limit: int = 100_000) -> Templates:
    """Templates as a table. They are a query set whose shingles, ``limit`` at most, are held whole."""
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "template int, license string, body string")
    cut = stage(given.withColumn("w", plain_words(text_of("body"))).withColumn("runs", F.array_distinct(shingles(F.col("w"), width)))
                .withColumn("m", F.size("runs")).withColumn("hashes", _hashes(F.col("w"), width))
                .withColumn("words", F.size("w")).drop("w", "body"), "templates")
    short = cut.where("m = 0").count()
    if short:
        raise ValueError(f"{short} templates have fewer than {width} words")
    total = cut.agg(F.sum("m")).first()[0] or 0
    if total > limit:
        raise ValueError(f"{total} shingles of templates; scan them in several calls of {limit} at most")
    known = [r[0] for r in cut.select(F.explode("hashes")).distinct().collect()]
    sizes = sorted(r[0] for r in cut.select("m").distinct().collect())
    return Templates(cut.drop("hashes"), sizes, sorted(known))


def scan_licenses(docs: DataFrame, templates: Templates, containment: float = CONTAINMENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, license, template, containment, start_word) of every document and template that it holds.

    A template is held if a window has at least the share ``containment`` of its distinct shingles. The
    best window is told, the first of equals; ``start_word`` counts from 0. Notices of related licenses share
    most of their words: of templates whose places overlap only the best is told, that of the highest
    containment, then of more shingles, then the first. For every number of shingles
    that templates have, windows somewhat longer overlap so that each place lies whole in one. Windows
    without any shingle of a template can't hold one and are passed over; the others are met with
    templates by MinHash bands and verified on the shingles themselves.

    ``docs`` needs doc_id and text; other columns are ignored. Null, empty and shorter texts hold none.
    Each copy of a repeated row has its own results. Texts don't leave their tasks: only windows near a
    template's shingle do.
    """
    known = F.array(*(F.lit(k).cast("bigint") for k in templates.known))
    rows = spread_rows(docs).select("doc_id", F.monotonically_increasing_id().alias("row"),
                                    plain_words(text_of("text")).alias("words"))
    hit = rows.withColumn("h", _hashes(F.col("words"), width)).where(F.arrays_overlap("h", known))
    anchors = let(F.array_distinct(F.array_intersect("h", known)), lambda own: F.filter(
        F.transform("h", lambda x, i: F.when(F.array_contains(own, x), i)), lambda i: i.isNotNull()))

    def of_size(at: Column, m: int) -> Column:
        step = window_step(m)
        first = lambda i: F.greatest(F.floor((i - (m + step - 1) + step) / step), F.lit(0).cast("bigint"))
        numbers = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(first(i), F.floor(i / step)))))
        return F.transform(numbers, lambda k: F.struct(
            F.lit(m).alias("m"), (k * step).cast("int").alias("start"),
            F.slice(F.col("words"), (k * step + 1).cast("int"), m + step - 1 + width - 1).alias("words")))

    def windows(at: Column) -> Column:
        return F.concat(*(of_size(at, m) for m in templates.sizes))

    found = hit.select("doc_id", "row", F.explode(let(anchors, windows)).alias("w")).select(
        "doc_id", "row", "w.m", "w.start", shingles(F.col("w.words"), width).alias("runs"))
    keyed = found.select("*", F.explode(band_keys(F.col("runs"))).alias("band"))
    own = templates.table.select("template", "license", F.col("m"), F.col("runs").alias("wanted"),
                                 F.explode(band_keys(F.col("runs"))).alias("band"))
    met = keyed.join(broadcast_below(own, 4096), ["m", "band"])
    share = F.size(F.array_intersect("runs", "wanted")).cast("double") / F.col("m")
    # where the template's first shingle found stands in the window
    place = F.col("start") + let(F.array_intersect("runs", "wanted"), lambda x: F.array_position("runs", F.get(x, 0)).cast("int")) - 1
    held = met.select("doc_id", "row", "license", "template", "m", share.alias("containment"), place.alias("start_word")).where(
        F.col("containment") >= containment)
    best = held.groupBy("row", "doc_id", "license", "template", "m").agg(
        F.min(F.struct((-F.col("containment")).alias("c"), "start_word")).alias("b"))
    # a document has at most one row for each template here, so its list is bounded by their number
    hits = best.groupBy("row", "doc_id").agg(F.collect_list(F.struct(
        F.col("b.c").alias("c"), (-F.col("m")).alias("m"), "template", "license", F.col("b.start_word").alias("start"))).alias("hits"))
    end = lambda h: h["start"] - h["m"] + width - 1
    beaten = lambda a: F.exists("hits", lambda b: (
        F.struct(b["c"], b["m"], b["template"]) < F.struct(a["c"], a["m"], a["template"])) & (b["start"] < end(a)) & (a["start"] < end(b)))
    kept = hits.select("doc_id", F.explode(F.filter("hits", lambda a: ~beaten(a))).alias("h"))
    return kept.select("doc_id", "h.license", "h.template", (-F.col("h.c")).alias("containment"), F.col("h.start").alias("start_word"))
