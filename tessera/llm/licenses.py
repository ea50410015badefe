"""License scans with DataFrame operations alone.

Texts become lower-cased words of letters and digits and hashes of every five of them.  Overlapping windows over these,
of 1, 4 and 16 shingles (powers of four up to `widest`) that begin at every half of their width, retrieve templates by MinHash bands of one
register each.  A template is indexed by its windows at every offset, of the widest kind of which a verbatim copy of it
holds one whole wherever it begins; so some window of a copy equals one of the template's, and at similarity s a window
of the widest kind collides with probability 1 - (1 - s) ** `bands`, that is 0.999936 at 0.8.  (A window of one shingle
has one band, of four four: what they lack in bands they make up by their number.)  Minima of a window are those of its
two halves.  Blocks of half the widest window are rows, whose minima compiled code takes.

Retrieved templates are then verified: the share of a template's distinct shingles that stand in one place of the text,
where a place is a run of hits whose offsets against the template differ by `slack` of its length at most.

Templates are a bounded table, which is sent to all tasks: `templates` holds at most `most` texts.  Bands and shingles of
the texts meet it by a join on keys.  Cases: null, empty and shorter texts match nothing; every place of a template is a
row, in very long texts too; repeated rows (equal id and text) give their places once; null ids stay null; an empty table
gives no rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import materialize

# Notices as their licences publish them.
TEMPLATES = (
    ("mit-line", "MIT", "Released under the MIT License."),
    ("apache-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3-line", "GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-line", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-line", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ofl-line", "OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("bsd-line", "BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc0-line", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("epl-2-header", "EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("lgpl-2-header", "LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("zlib", "Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("boost", "BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'),
    ("mpl-2-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("apache-header", "Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("gpl-3-header", "GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("mit", "MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("bsd-3", "BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
)


@dataclass(frozen=True)
class Params:
    """widest must be a power of four; up to broadcast_keys keys of templates are sent to all tasks, more are joined by a
    shuffle."""

    shingle: int = 5
    threshold: float = 0.8
    widest: int = 16
    bands: int = 6
    slack: float = 0.25
    most: int = 10_000
    broadcast_keys: int = 500_000

    @property
    def widths(self) -> list[int]:
        return [1 << k for k in range(0, self.widest.bit_length(), 2)]

    def bands_of(self, width: int) -> int:
        return min(width, self.bands)


WORD = r"[\p{L}\p{N}]+"
EMPTY = "array<bigint>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingles(text: Column, p: Params) -> Column:
    """Hashes of every p.shingle neighbouring words; empty if there are fewer."""

    def of(w: Column) -> Column:
        return _each(F.size(w) - p.shingle + 1, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(p.shingle)]))

    return _given(words(text), of)


def _mask(j: int) -> int:
    """Register j is the least hash after an exclusive or with its mask; multiples of the golden ratio spread them."""
    return (j * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63


def _key(least: Column, width: int, j: int) -> Column:
    """Keeps the widths' and bands' registers apart."""
    return least.bitwiseXOR(F.lit(_mask(1_000 * width + j)))


def _given(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _each(count: Column, f) -> Column:
    """Array of f(i) for i from 0 to count - 1."""
    full = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), f)
    return F.when(count > 0, full).otherwise(F.array().cast(EMPTY))


def block(widths: list[int]) -> tuple[int, int]:
    """Shingles from one block of a text to the next, and shingles that a block's windows reach over."""
    last = max(widths, default=1)
    step = max(8, last // 2)
    return step, step + last // 2


def block_starts(h: Column, widths: list[int]) -> Column:
    """First shingle of each block; empty without shingles."""
    step = block(widths)[0]
    return F.when(F.size(h) > 0, F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))


def block_keys(x: list[Column], widths: list[int], p: Params) -> list[tuple[int, Column]]:
    """Keys of all bands of the windows of these widths above 1 that begin in a block, each with the shingles that the
    block must have for it; x: the block's shingles, whatever number where the text has ended."""
    last, step, keys = max(widths, default=1), block(widths)[0], []
    for j in range(p.bands_of(last) if last > 1 else 0):
        # Least of every `width` / 2 neighbours; windows begin at every half of their width.
        least, width = [c.bitwiseXOR(F.lit(_mask(j))) for c in x], 2
        while width <= last:
            half = width // 2
            if width in widths and j < p.bands_of(width):
                keys += [(i * half + width, _key(F.least(least[i], least[i + 1]), width, j)) for i in range(step // half)]
            least, width = [F.least(*y) for y in zip(least[::2], least[1::2], strict=False)], 2 * width
    return keys


def _block_at(h: Column, at: Column, widths: list[int]) -> list[Column]:
    return [F.coalesce(F.get(h, at + k), F.lit(0).cast("long")) for k in range(block(widths)[1])]


def text_keys(h: Column, widths: list[int], p: Params) -> Column:
    """Keys of all blocks of a text in one array."""
    if max(widths, default=1) == 1:
        return F.array().cast(EMPTY)

    def of(at: Column) -> Column:
        keys = block_keys(_block_at(h, at, widths), widths, p)
        return F.array_compact(F.array(*[F.when(need <= F.size(h) - at, key) for need, key in keys]))

    return F.flatten(F.transform(block_starts(h, widths), of))


def template_width(n: Column, p: Params) -> Column:
    """Widest window of which any verbatim copy of n shingles holds one that begins at a half of the width."""
    return F.greatest(*[F.when(n >= (3 * w - 2 + 1) // 2, w).otherwise(1) for w in p.widths], F.lit(1))


def template_keys(h: Column, width: int, p: Params) -> Column:
    """Keys of all bands of a template's windows of this width, at every offset; the shingle itself for width 1."""
    if width == 1:
        return h

    def band(j: int) -> Column:
        return _each(F.size(h) - width + 1, lambda i: _key(F.array_min(F.transform(F.slice(h, i + 1, width), lambda x: x.bitwiseXOR(F.lit(_mask(j))))), width, j))

    return F.concat(*[band(j) for j in range(p.bands_of(width))])


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, license, text as a DataFrame."""
    rows = json.dumps([{"template": a, "license": b, "text": c} for a, b, c in templates])
    kind = "array<struct<template:string,license:string,text:string>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(rows), kind)).alias("x")).select("x.*")


def scan(docs: DataFrame, templates: DataFrame | None = None, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, template, license, first_word, last_word (counted from 0), containment: a row for each place."""
    spark = docs.sparkSession
    known = template_table(spark) if templates is None else templates
    h = known.limit(p.most + 1).select("template", "license", shingles(F.col("text"), p).alias("h")).withColumn("width", template_width(F.size("h"), p))
    h = materialize(h.filter(F.size("h") > 0), "templates")
    if h.count() > p.most:
        raise ValueError(f"more than {p.most} templates")
    widths = sorted(r[0] for r in h.select("width").distinct().collect())  # as many as there are kinds of windows
    none = F.lit(None)
    pieces = h.select(F.posexplode("h").alias("offset", "key"), "template", "license", F.size(F.array_distinct("h")).alias("n"), F.lit(True).alias("hit"), (F.col("width") == 1).alias("retrieves"))
    index = pieces
    for w in widths[widths[:1] == [1] :]:
        keys = h.filter(F.col("width") == w).select(F.explode(template_keys(F.col("h"), w, p)).alias("key"), "template").distinct()
        index = index.unionByName(keys.select(none.cast("int").alias("offset"), "key", "template", none.cast("string").alias("license"), none.cast("int").alias("n"), F.lit(False).alias("hit"), F.lit(True).alias("retrieves")))
    index = materialize(index, "template-keys")
    near = F.broadcast if index.count() <= p.broadcast_keys else lambda df: df

    node = F.md5(F.coalesce(F.col(text), F.lit("")))
    rid = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), node)))
    rows = docs.select(rid.alias("rid"), F.col(doc_id).alias("doc_id"), shingles(F.col(text), p).alias("h"))
    # A row a block: compiled code takes a block's minima, where functions of whole arrays are interpreted by element.
    # An outer explode keeps the optimiser from computing the arrays once more in an inferred filter.
    step = block(widths)[0]
    blocks = rows.select("rid", "doc_id", "h", F.explode_outer(block_starts(F.col("h"), widths)).alias("at"))
    x = _block_at(F.col("h"), F.col("at"), widths)
    keys = [*((k + 1, x[k]) for k in range(step)), *block_keys(x, widths, p)]  # the block's shingles, then its bands
    blocks = blocks.select("rid", "doc_id", "at", (F.size("h") - F.col("at")).alias("left"), F.array(*[key for _, key in keys]).alias("keys"))
    each = blocks.select("rid", "doc_id", "at", "left", F.posexplode_outer("keys").alias("k", "key"))
    each = each.filter(F.get(F.array(*[F.lit(need) for need, _ in keys]), F.col("k")) <= F.col("left"))
    # Written as an equality, the kind would become a second key of the join, whose table is slower than one of numbers.
    same = (F.col("hit") & (F.col("k") < step)) | (~F.col("hit") & (F.col("k") >= step))
    met = each.join(near(index), "key").filter(same).withColumn("pos", F.col("at") + F.col("k"))
    found = materialize(met.drop("key", "at", "left", "k"), "found")
    retrieved = found.filter("retrieves").select("rid", "template").distinct()
    hits = found.filter("hit").select("rid", "doc_id", "template", "license", "n", "pos", "offset").distinct().join(retrieved, ["rid", "template"], "left_semi")
    hits = hits.withColumn("start", F.col("pos") - F.col("offset"))
    order = Window.partitionBy("rid", "template").orderBy("start", "pos")
    gap = F.col("start") - F.lag("start").over(order) > F.greatest(F.lit(1.0), p.slack * F.col("n"))
    placed = hits.withColumn("place", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(order))
    # A shingle's places in the template tell shingles apart: the first stands for all of them.
    first = pieces.groupBy("template", "key").agg(F.min("offset").alias("least"), F.collect_list("offset").alias("offsets")).select("template", "least", F.explode("offsets").alias("offset"))
    placed = placed.join(near(first), ["template", "offset"])  # no more rows than the index has
    per = placed.groupBy("rid", "template", "place").agg(F.first("doc_id").alias("doc_id"), F.first("license").alias("license"), F.min("pos").cast("long").alias("first_word"), (F.max("pos") + p.shingle - 1).cast("long").alias("last_word"), (F.countDistinct("least") / F.first("n")).alias("containment"))
    return per.filter(F.col("containment") >= p.threshold).select("doc_id", "template", "license", "first_word", "last_word", "containment")


def oracle(templates=TEMPLATES, p: Params = Params()) -> str:
    """The same rows in DuckDB's SQL, with shingles compared as strings."""
    import re

    rows = []
    for name, licence, text in templates:
        w = re.findall(r"[^\W_]+", text.lower())
        parts = [" ".join(w[i : i + p.shingle]) for i in range(len(w) - p.shingle + 1)]
        rows += [f"('{name}', '{licence}', '{x}', {i}, {len(set(parts))})" for i, x in enumerate(parts)]
    k = p.shingle
    return f"""
WITH pieces(template, license, shingle, off, n) AS (VALUES {", ".join(rows)}),
texts AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM texts),
spots AS (SELECT doc_id, t, w, unnest(range(len(w) - {k - 1})) AS pos FROM split WHERE len(w) >= {k}),
hits AS (SELECT doc_id, t, pos, template, license, shingle, n, pos - off AS start
         FROM (SELECT doc_id, t, pos, array_to_string(w[pos + 1 : pos + {k}], ' ') AS shingle FROM spots) JOIN pieces USING (shingle)),
gaps AS (SELECT *, start - lag(start) OVER (PARTITION BY doc_id, t, template ORDER BY start, pos) AS gap FROM hits),
places AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > greatest(1.0, {p.slack} * n) THEN 1 ELSE 0 END)
                  OVER (PARTITION BY doc_id, t, template ORDER BY start, pos ROWS UNBOUNDED PRECEDING) AS place FROM gaps)
SELECT doc_id, template, any_value(license) AS license, CAST(min(pos) AS BIGINT) AS first_word, CAST(max(pos) + {k - 1} AS BIGINT) AS last_word,
       CAST(count(DISTINCT shingle) AS DOUBLE) / any_value(n) AS containment
FROM places GROUP BY doc_id, t, template, place HAVING CAST(count(DISTINCT shingle) AS DOUBLE) / any_value(n) >= {p.threshold}
"""
