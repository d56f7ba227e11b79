"""License scans: MinHash bands over overlapping windows find templates, exact shingle
containment verifies them; built-in functions only.

Texts are lower-cased and split at everything but ASCII letters, digits and non-ASCII;
shingles are three words. A size class has windows of ``w`` words that overlap by half,
and takes the templates of at most ``w / 2`` words, each of which then lies whole inside
some window. All of a window's shingles are hashed by one permutation into ``bins``
ranges, and the least hash of each range is one band of one row. A template is
retrieved where it has a band in common with the window; the number of ranges is the
least that misses a template contained to ``least`` with probability under ``miss``.
Retrieved templates are verified by exact containment in the window.

Templates come as a table (name, text) or a mapping. Their bands are joined; they are
broadcast while there are at most ``LIGHT_BANDS`` of them.

Defined cases: null and empty texts match nothing, nor do templates of fewer than three
words; texts of any length are scanned whole; repeated rows of an id and text are one
document here, rows without an id are told apart by their text; a license is reported
once per document with its best window; other columns than doc_id and text don't matter;
no rows give no findings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basestream.llm.common import materialise
from basestream.llm.fingerprints import let

#: Wording of common public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
}
SEPARATORS = r"[\x00-/:-`{-\x7f]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), lambda w: w != "")


def shingle_at(h: Column, i: Column) -> Column:
    return F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))


def bins_needed(shingles: int, window: int, least: float, miss: float) -> int:
    """Ranges of hash space, a power of two. Of the shingles that a template and a window
    share, each misses if another one of its range is less, which of ``load`` shingles a range
    happens with probability 1 - (1 - exp(-load)) / load; all of them must."""
    shared = math.ceil(least * shingles)
    union = window - 2 + shingles - shared
    bins = 2
    while bins < 1 << 20:
        load = union / bins
        if (1 - (1 - math.exp(-load)) / load) ** shared <= miss:
            break
        bins *= 2
    return bins


def bands(shingles: Column, bins: int) -> Column:
    """The least hash of each of ``bins`` equal ranges of hash space that has any."""
    shift = 64 - (bins.bit_length() - 1)
    ordered = F.sort_array(shingles)
    return let(ordered, lambda a: F.filter(a, lambda v, i: (i == 0) | (F.shiftright(v, shift) != F.shiftright(F.get(a, i - 1), shift))))


def shingles_of(text: Column) -> Column:
    """Hashes of all three-word shingles, in order; empty for fewer words."""
    made = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: shingle_at(h, i))
    none = F.array().cast("array<bigint>")
    return let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= 3, made(h)).otherwise(none))


#: Template bands that are broadcast at most (24 bytes each and the name).
LIGHT_BANDS = 300_000


def template_table(spark: SparkSession, templates: dict[str, str] | DataFrame | None) -> DataFrame:
    """(license, template, w): distinct shingles and the size class, the least power of
    two from 16 on of which the template's words fill half at most."""
    if isinstance(templates, DataFrame):
        rows = templates.select(F.col("name").alias("license"), F.col("text").alias("text"))
    else:
        made = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in (templates or TEMPLATES).items()])
        rows = spark.range(1).select(F.explode(made).alias("t")).select("t.*")
    hashed = rows.select("license", F.explode(F.array(shingles_of(F.col("text")))).alias("s")).where(F.size("s") > 0)
    w = F.greatest(F.lit(16), F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * (F.size("s") + 2)))).cast("int"))
    return hashed.select("license", F.array_distinct("s").alias("template"), w.alias("w"))


def window(shingles: Column, k: Column, w: Column) -> Column:
    return F.slice(shingles, (k * (w / 2) + 1).cast("int"), (w - 2).cast("int"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, least: float = 0.8, miss: float = 1e-3) -> DataFrame:
    """(doc_id, license, containment, first_word): every template a text contains."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    classes = {r["w"]: bins_needed(r["n"], r["w"], least, miss) for r in table.groupBy("w").agg(F.min(F.size("template")).alias("n")).collect()}
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Explode keeps the shingles a column of their own, computed once a text.
    hashed = text.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(F.array(shingles_of(F.col("text")))).alias("s")).where(F.size("s") > 0)

    def windows_of(w: int, bins: int) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size("s") + 2) / (w / 2)).cast("int") - 2)
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.lit(w).alias("w"), k.alias("k"), bands(window(F.col("s"), k, F.lit(w)), bins).alias("bands")))

    parts, found = F.lit(None), None
    for w, bins in sorted(classes.items()):
        own = table.where(F.col("w") == w).select("license", "w", F.explode(bands(F.col("template"), bins)).alias("band"))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.range(0).select(F.col("id").alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.col("id").alias("first_word"))
    parts = F.flatten(F.array(*[windows_of(w, bins) for w, bins in sorted(classes.items())]))
    looked = hashed.select("doc_id", "text_key", F.explode(parts).alias("x")).select("doc_id", "text_key", "x.w", "x.k", F.explode("x.bands").alias("band"))
    banded = F.broadcast(found) if found.count() <= LIGHT_BANDS else found
    retrieved = materialise(looked.join(banded, ["w", "band"]).select("doc_id", "text_key", "w", "k", "license").distinct())
    # The shingles of the texts that have candidates, again, and the candidates of each text.
    asked = retrieved.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("w", "k", "license")).alias("asked"))
    asked = asked.withColumnsRenamed({"doc_id": "asked_id", "text_key": "asked_key"})
    if asked.count() <= LIGHT_BANDS // 10:
        asked = F.broadcast(asked)
    again = text.withColumn("text_key", F.xxhash64("text")).join(asked, F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("text_key") == F.col("asked_key")))
    again = again.select("doc_id", "text_key", "asked", F.explode(F.array(shingles_of(F.col("text")))).alias("s"))
    cut = again.select("doc_id", "text_key", F.explode(F.transform("asked", lambda x: F.struct(x["license"].alias("license"), x["w"].alias("w"), x["k"].alias("k"), window(F.col("s"), x["k"], x["w"]).alias("s")))).alias("x"))
    known = F.broadcast(table.drop("w")) if found.count() <= LIGHT_BANDS else table.drop("w")
    checked = cut.select("doc_id", "text_key", "x.*").join(known, "license").select(
        "doc_id", "text_key", "license", (F.size(F.array_intersect("s", "template")) / F.size("template")).alias("containment"),
        let(F.filter("s", lambda v: F.array_contains("template", v)), lambda hit: F.array_position("s", F.get(hit, 0)) - 1 + (F.col("k") * F.col("w") / 2).cast("long")).alias("first_word"),
    ).where(F.col("containment") >= least)
    best = checked.groupBy("doc_id", "text_key", "license").agg(F.max(F.struct("containment", (-F.col("first_word")).alias("at"))).alias("b"))
    return best.select("doc_id", "license", F.round("b.containment", 6).alias("containment"), (-F.col("b.at")).cast("long").alias("first_word"))
