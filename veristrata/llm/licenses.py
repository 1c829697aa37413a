"""License scans (operator 1), in DataFrame functions only.

Texts and templates become word sequences (lower-cased runs of letters and
digits) and hashes of five-word shingles; a template of fewer words is one
shingle of all its words. Overlapping windows of shingles get MinHash values;
each value is a band of one row. A window of ``2 * step`` shingles stands every
``step`` shingles, and templates are cut into chunks of at most ``step``
shingles, so that some window holds every chunk's place whole. Of a template
that is held by ``LEAST`` (0.8) some chunk is held by as much. If k of a chunk's
m shingles are held, in their places, its likeness with that window is
k / (2 * step + m - k) or more, and with ``bands`` values it collides with
probability 1 - (1 - likeness) ** bands or more; the step follows each chunk's
size class and the bands follow the step, so that this is 0.999 or more for
every chunk held by 0.8. (Where words are inserted, a chunk may lie in two
windows, and the odds are less.) A template needs one of its chunks to collide.
Retrieved templates are verified exactly: the share of the template's shingles
that the document holds must be ``least`` (0.8) or more.

Band keys are looked up in a bit table of fixed size first, so that the cost of a
window doesn't grow with the number of templates.

A document that holds no shingle of any template contains none by 0.8; such
documents are set aside before windows are made. That changes no result.

Scale: one pass over the texts, without a shuffle of them. The templates are a
parameter of bounded size (``MOST_TEMPLATES``) and are broadcast.

Defined results: null and empty texts match nothing; texts are read whole;
repeated rows give repeated matches; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, LEAST, MISS = 5, 0.8, 0.001
#: Size classes of chunks (shingles): windows of twice the size, one every so many shingles.
STEPS = (1, 2, 4, 8, 16)
MOST_TEMPLATES = 2_000
#: Words of 64 bits of the table that band keys are looked up in.
TABLE_WORDS = 4096

# Short notices of public licences, by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC", "This work is licensed under a Creative Commons Attribution"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
)


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template_id int, license string, text string")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(found: Column, size: int = SHINGLE) -> Column:
    """Hashes of all shingles, in order; of fewer words than ``size``, one of all."""

    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(found), of)[0]  # binds the words, which would be cut anew for every shingle


def bands(step: int) -> int:
    """MinHash values that make any chunk of a size class, held by LEAST, collide with probability 1 - MISS."""
    sizes = range(step // 2 + 1 if step > 1 else 1, step + 1)
    likeness = min(math.ceil(LEAST * m) / (2 * step + m - math.ceil(LEAST * m)) for m in sizes)
    return math.ceil(math.log(MISS) / math.log(1 - likeness))


def band_keys(set_: Column, step: int) -> Column:
    """The band keys of a non-empty array of shingle hashes: size class, band number and MinHash value in one hash."""

    def key(band: int) -> Column:
        return F.xxhash64(F.lit(step), F.lit(band), F.array_min(F.transform(set_, lambda x: F.xxhash64(x, F.lit(band)))))

    return F.array(*(key(j) for j in range(bands(step))))


def step_of(size: Column) -> Column:
    out = F.lit(STEPS[-1])
    for s in reversed(STEPS[:-1]):
        out = F.when(size <= s, F.lit(s)).otherwise(out)
    return out


def template_bands(known: DataFrame) -> tuple[dict[int, list[int]], list[int]]:
    """Templates by the band keys of their chunks, and the size classes in use. ``known`` is bounded by MOST_TEMPLATES."""
    chunk = STEPS[-1]
    cut = known.withColumn("chunk", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("shingles") - 1) / chunk).cast("int")), lambda i: F.slice("shingles", i * chunk + 1, chunk))))
    cut = cut.withColumn("step", step_of(F.size("chunk")))
    keys = F.lit(None).cast("array<bigint>")
    for s in STEPS:
        keys = F.when(F.col("step") == s, band_keys(F.col("chunk"), s)).otherwise(keys)
    of: dict[int, set[int]] = {}
    steps = set()
    for r in cut.select("template_id", "step", keys.alias("keys")).collect():
        steps.add(r["step"])
        for k in r["keys"]:
            of.setdefault(k, set()).add(r["template_id"])
    return {k: sorted(v) for k, v in sorted(of.items())}, sorted(steps)


def constants(values: Iterable[int]) -> Column:
    """A constant array of longs, from a string, as thousands of literals would weigh on the driver."""
    return F.split(F.lit(",".join(map(str, sorted(values)))), ",").cast("array<bigint>")


def scan(docs: DataFrame, templates: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """Matches: ``doc_id``, ``template_id``, ``license``, ``n_shingles`` of the template, ``n_found`` and ``containment``."""
    spark = docs.sparkSession
    known = (default_templates(spark) if templates is None else templates).select("template_id", "license", F.array_distinct(shingles(words(F.coalesce("text", F.lit(""))))).alias("shingles")).where(F.size("shingles") > 0)
    held = known.limit(MOST_TEMPLATES + 1).collect()
    if len(held) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    if not held:
        return docs.limit(0).selectExpr("doc_id", "cast(null as int) template_id", "cast(null as string) license", "cast(null as bigint) n_shingles", "cast(null as bigint) n_found", "cast(null as double) containment")
    known = spark.createDataFrame([tuple(r) for r in held], known.schema)
    every = constants({x for r in held for x in r["shingles"]})
    of, steps = template_bands(known)
    all_keys = constants(of)
    of_key = F.map_from_arrays(all_keys, F.transform(F.split(F.lit(";".join(",".join(map(str, ts)) for ts in of.values())), ";"), lambda x: F.split(x, ",").cast("array<int>")))
    table = [0] * TABLE_WORDS
    for k in of:
        table[(k >> 6) % TABLE_WORDS] |= 1 << (k & 63)
    bits = F.split(F.lit(",".join(str(x - (1 << 64) if x >> 63 else x) for x in table)), ",").cast("array<bigint>")

    def marked(k: Column) -> Column:
        return F.getbit(F.get(bits, F.pmod(F.shiftright(k, 6), F.lit(TABLE_WORDS)).cast("int")), F.pmod(k, F.lit(64)).cast("int")) == 1

    def retrieve(s: Column) -> Column:
        """Templates that share a band with one of the document's windows."""

        def windows(step: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(s) - step + 1), F.lit(step))
            return F.flatten(F.transform(starts, lambda i: F.filter(band_keys(F.slice(s, i, 2 * step if step > 1 else 1), step), marked)))

        return F.array_distinct(F.flatten(F.transform(F.array_intersect(F.concat(*(windows(x) for x in steps)), all_keys), lambda k: F.element_at(of_key, k))))

    kept = F.filter(F.array(shingles(words(F.coalesce("text", F.lit(""))))), lambda s: F.arrays_overlap(s, every))
    # one generator, so that a text's shingles are made once; the outer form keeps Spark from asking for its size beforehand
    rows = docs.select("doc_id", F.explode_outer(F.transform(kept, lambda s: F.struct(s.alias("shingles"), retrieve(s).alias("found")))).alias("g")).where("g is not null")
    found = rows.select("doc_id", "g.shingles", F.explode_outer("g.found").alias("t_id")).where("t_id is not null")
    sized = F.broadcast(known.select("template_id", "license", F.col("shingles").alias("t_shingles")))  # MOST_TEMPLATES rows at most
    exact = found.join(sized, F.col("template_id") == F.col("t_id")).withColumn("n_shingles", F.size("t_shingles").cast("long")).withColumn("n_found", F.size(F.array_intersect("t_shingles", "shingles")).cast("long"))
    return exact.select("doc_id", "template_id", "license", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment")).where(F.col("containment") >= least)


def oracle() -> str:
    """The same matches in DuckDB SQL: exact containment of every template in every document."""
    rows = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(TEMPLATES))
    grams = "case when len(w) >= 5 then list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end"
    cut = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
with t as (select * from (values {rows}) v(template_id, license, text)),
ts as (select template_id, license, {grams} s from (select template_id, license, {cut} w from t)),
one as (select template_id, license, len(s) n_shingles, unnest(s) g from ts),
d as (select doc_id, row_number() over () r, {cut} w from documents),
dg as (select doc_id, r, unnest({grams}) g from d),
hit as (select doc_id, r, template_id, license, n_shingles, count(*) n_found from dg join one using (g) group by all)
select doc_id, template_id, license, n_shingles, n_found, n_found / n_shingles as containment from hit where n_found / n_shingles >= 0.8"""
