"""License scans by MinHash bands over overlapping text windows, in DataFrame operations only.

A template is a notice as it stands in files, cut into three-word shingles.  Templates are
sorted by size: one with up to s shingles (s a power of two, more than s/2) is looked for in
windows of 2s shingles that begin every s shingles, so each occurrence lies wholly in one
window and makes up a quarter of it or more.  With 32 bands of one MinHash value a window
that holds the template is retrieved with a probability of at least 1 - 0.75^32 = 0.9999.

A window can only collide with a template in a band if it holds that template's smallest
shingle of the band.  So one pass over the documents keeps those that hold such a shingle,
and only windows around such places are hashed; no other window could collide.  Retrieved
windows are verified exactly: the share of the template's shingles that the window holds.

The only thing the driver sees are the templates' own smallest shingles.  Windows carry
their few shingles, never the text, and are spread by their rows.

Null and empty texts match nothing and give no rows; repeated rows are reported each; an
empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.llm.common import column
from foretally.llm.decontamination import cleaned
from foretally.session import durable

SHINGLE = 3
BANDS = 32
CONTAINED = 0.8

# fixed values: the wording of public license notices
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                  "Free Software Foundation",
    "LGPL header": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
                   "by the Free Software Foundation",
    "MIT": "Released under the MIT License",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                      "documentation files, to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}

# fixed values: the words that tell a notice from its relatives and from its older versions
PHRASES = {
    "Apache-2.0": "the Apache License, Version 2.0",
    "Apache-2.0 header": "licenses/LICENSE-2.0",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "GPL-3.0": "the GNU General Public License, version 3",
    "GPL header": "terms of the GNU General Public License as published",
    "LGPL header": "terms of the GNU Lesser General Public License as published",
    "MIT": "the MIT License",
    "MPL-2.0": "Mozilla Public License, v. 2.0",
}


def shingles_of(text: Column) -> Column:
    """Shingle hashes of a cleaned text in order; none for fewer than three words."""
    words = F.split(text, " ")
    count = F.size(words) - (SHINGLE - 1)
    # neighbours side by side, so that the words are cut once and not for every shingle
    beside = F.arrays_zip(*[F.slice(words, k + 1, F.greatest(count, F.lit(0))).alias(f"w{k}") for k in range(SHINGLE)])
    return F.transform(beside, lambda z: F.xxhash64(*[z[f"w{k}"] for k in range(SHINGLE)]))


def smallest(part: Column, band: int) -> Column:
    """The band's MinHash value of an array of shingles."""
    return F.array_min(F.transform(part, lambda h: F.xxhash64(h, F.lit(band))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, shingles, span): distinct shingles and the size class of each template."""
    rows = spark.createDataFrame(list(templates.items()), "license string, notice string")
    cut = rows.select("license", F.array_distinct(shingles_of(cleaned(F.col("notice")))).alias("shingles")).filter(F.size("shingles") > 0)
    return cut.withColumn("span", F.pow(F.lit(2), F.ceil(F.log2(F.size("shingles")))).cast("int"))


def band_values(frame: DataFrame, part: str, keep: list[str]) -> DataFrame:
    """One row per band: (keep, band, value)."""
    values = F.array(*[F.struct(F.lit(k).alias("band"), smallest(F.col(part), k).alias("value")) for k in range(BANDS)])
    return frame.select(*keep, F.explode(values).alias("v")).select(*keep, "v.band", "v.value")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, carry: list[str] | None = None,
         phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per document and license found: ``row`` (the carried columns), ``license``,
    ``n_found`` and ``n_shingles`` (of the template), ``window_start`` (the word at which the
    first window that holds it best begins).

    With ``phrases`` a window counts for a template only if it holds the template's phrase
    word for word; a template without one needs the shingles alone."""
    spark = docs.sparkSession
    known = durable(template_table(spark, templates))
    spans = sorted({r["span"] for r in known.select("span").collect()})
    # the shingle behind each template's value of each band: at most 32 for a template
    valued = F.transform("shingles", lambda h: F.struct(*[F.struct(F.xxhash64(h, F.lit(k)).alias("value"), h.alias("h")).alias(f"b{k}") for k in range(BANDS)]))
    keys = known.select(valued.alias("v")).select(F.explode(F.array(*[F.array_min(F.col(f"v.b{k}"))["h"] for k in range(BANDS)])).alias("h"))
    wanted = F.array(*[F.lit(r["h"]) for r in keys.distinct().collect()]).cast("array<bigint>")

    cut = docs.select(F.struct(*[column(docs, c) for c in carry or docs.columns]).alias("row"),
                      shingles_of(cleaned(F.coalesce(column(docs, "text"), F.lit("")))).alias("shingles"))
    possible = durable(cut.filter(F.arrays_overlap("shingles", wanted)).withColumn("rid", F.monotonically_increasing_id()))

    places = F.filter(F.transform("shingles", lambda h, i: F.when(F.array_contains(wanted, h), i)), lambda i: i.isNotNull())
    around = F.flatten(F.transform(places, lambda i: F.array(*[
        F.struct(F.lit(s).alias("span"), (F.floor(i / s) - back).cast("int").alias("number")) for s in spans for back in (0, 1)])))
    windows = F.transform(F.filter(F.array_distinct(around), lambda w: w["number"] >= 0), lambda w: F.struct(
        w["span"].alias("span"), (w["number"] * w["span"]).alias("window_start"),
        F.array_distinct(F.slice("shingles", w["number"] * w["span"] + 1, 2 * w["span"])).alias("part")))
    near = durable(possible.select("rid", F.explode(windows).alias("w")).select("rid", "w.*"))

    mine = band_values(near, "part", ["rid", "span", "window_start"])
    theirs = band_values(known, "shingles", ["license", "span"])
    retrieved = mine.join(theirs, ["span", "band", "value"]).select("rid", "span", "window_start", "license").distinct()

    verified = (retrieved.join(near, ["rid", "span", "window_start"]).join(known.select("license", "shingles"), "license")
                .select("rid", "license", "window_start", F.size("shingles").alias("n_shingles"),
                        F.size(F.array_intersect("part", "shingles")).alias("n_found"))
                .filter(F.col("n_found") >= CONTAINED * F.col("n_shingles")))
    if phrases:
        told = durable(spark.createDataFrame(list(phrases.items()), "license string, phrase string")
                       .select("license", shingles_of(cleaned(F.col("phrase"))).alias("phrase")))
        # all verified windows, not only the best: a relative's notice may hold more shingles than a changed real one
        placed = verified.join(near.select("rid", "window_start", "span").distinct(), ["rid", "window_start"]).join(
            known.select("license", "span"), ["license", "span"]).join(told, "license", "left").join(possible.select("rid", "shingles"), "rid")
        inside = F.slice("shingles", F.col("window_start") + 1, 2 * F.col("span"))
        starts = F.transform(inside, lambda h, i: F.when(h == F.col("phrase")[0], i + 1))
        holds = F.exists(starts, lambda i: i.isNotNull() & (F.slice(inside, F.coalesce(i, F.lit(1)), F.size("phrase")) == F.col("phrase")))
        verified = placed.filter(F.col("phrase").isNull() | holds).select(verified.columns)
    best = (verified.groupBy("rid", "license", "n_shingles")
            .agg(F.max(F.struct("n_found", (-F.col("window_start")).alias("back"))).alias("best"))
            .select("rid", "license", F.col("best.n_found").alias("n_found"), "n_shingles", (-F.col("best.back")).alias("window_start")))
    return possible.select("rid", "row").join(best, "rid").select("row", "license", "n_found", "n_shingles", "window_start")
